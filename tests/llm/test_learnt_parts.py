"""Identifiers that contexts and shapes discover, and secrets in parts, against brute force and planted cases."""

import random
import re

from meshlark.llm import pii, queries, secret_scan

from .test_text_operators import PII, rows, spans

SF = "/root/testdata/sf0.01"
WORDS = "the of and lamp river stone quiet harbour seven letter paper morning window garden".split()


def found(text, kinds):
    return [(int(x.split(":")[1]), int(x.split(":")[2])) for x in spans(text, kinds).split(",") if x]


def last_two(x):
    return " ".join(x.split("\n")[-1].rstrip(" ").split(" ")[-2:])


def instances(text):
    """(start, end, text, words before, word after) of runs of up to three words with digits."""
    hits = list(re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*", text, re.A))
    gaps = [text[a.end() if a else 0 : b.start() if b else len(text)] for a, b in zip([None, *hits], [*hits, None])]
    before = [last_two(g) for g in gaps]
    after = [g.split("\n")[0].lstrip(" ").split(" ")[0] for g in gaps[1:]]
    for i, h in enumerate(hits):
        left = before[i] if i == 0 or "\n" in gaps[i] else last_two(" ".join(x for x in (before[i - 1], hits[i - 1][0], before[i]) if x or x == hits[i - 1][0]))
        whole, end = "", 0
        for n in range(3):
            if i + n >= len(hits) or (n and gaps[i + n] != " "):
                break
            whole, end = (whole + " " + hits[i + n][0]).lstrip(" "), hits[i + n].end()
            right = hits[i + n + 1][0] if i + n + 1 < len(hits) and gaps[i + n + 1] == " " else after[i + n]
            a, b = 0, len(whole)
            while a < b and not (whole[a].isalpha() or whole[a].isnumeric() or whole[a] == "+"):
                a += 1
            while b > a and not (whole[b - 1].isalpha() or whole[b - 1].isnumeric()):
                b -= 1
            if sum(c.isalpha() or c.isnumeric() for c in whole[a:b]) >= 5:
                yield h.start() + a, end - (len(whole) - b), whole[a:b], left, right


def patterns(text, left, right):
    shape = re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", text))
    rough = re.sub("9+", "n", re.sub("9{5,}", "N", shape))
    one, left, right = left.split(" ")[-1].lower(), left.lower(), right.lower()
    out = {("shape", shape)}
    if one:
        out.add(("1", one, rough))
    if " " in left:
        out |= {("2", left, rough), ("said", left)}
    if right:
        out.add(("after", right, rough))
    if one and right:
        out.add(("round", one, right, rough))
    return out


def brute(texts, rounds=3, least=5, sure=0.9):
    judged, edges = [], {}
    for d, t in texts.items():
        base = found(t, PII)
        # what a base pattern took and dropped, just so, is no candidate
        dropped = {m.span() for _, pattern, keep in PII for m in re.finditer(pattern, t) if not keep(m[0])}
        for s, e, x, left, right in instances(t):
            seed = (s, e) in base
            if not seed and (s, e) in dropped:
                continue
            if seed or not any(a < e and s < b for a, b in base):
                judged.append((d, s, e, x.lower(), seed))
                for p in patterns(x, left, right):
                    edges[p, x.lower()] = edges.get((p, x.lower()), False) or seed
    seeds = {i for (_, i), s in edges.items() if s}
    score = {i: float(i in seeds) for _, i in edges}
    members = {}
    for p, i in edges:
        members.setdefault(p, []).append(i)
    for _ in range(rounds):
        sure_ = {}
        for p in {p for p, _ in edges}:
            own = [score[i] for i in members[p]]
            if sum(x >= sure for x in own) >= least:
                sure_[p] = sum(own) / (len(own) + 1)
        best = dict.fromkeys(score, 0.0)
        for p, i in edges:
            best[i] = max(best[i], sure_.get(p, 0.0))
        score = {i: 1.0 if i in seeds or best[i] >= sure else best[i] for i in score}
    new = {(d, s, e) for d, s, e, x, seed in judged if not seed and score[x] >= sure}
    return {x for x in new if not any(y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] and y != x for y in new)}


def added(got, kind):
    return {(d, *map(int, x.split(":")[1:])) for d, r in got.items() for x in r["spans"].split(",") if x.startswith(f"{kind}:")}


def test_discovered_identifiers_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = brute(texts)
    assert want and added(rows(queries.op3_pii(spark, SF)), "id") == want


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_planted_identifiers(spark):
    """Badge numbers that no base pattern knows: learnt from mails in the same places, then from their own shape."""
    rng, docs, want = random.Random(5), {}, set()
    for d in range(500):
        text = prose(rng, 20)
        if d < 400:
            text += f" staff badge u{d}@corp.example here " + prose(rng, 10)
        elif d < 430:
            text += " staff badge "
            want.add((d, len(text), len(text) + 10))
            text += f"QX-{10000 + d}-z here " + prose(rng, 10)
        elif d < 432:  # other places, the same shape
            text += " somewhere "
            want.add((d, len(text), len(text) + 10))
            text += f"QX-{10000 + d}-z, " + prose(rng, 10)
        else:
            text += f" in {1900 + d % 120} about {d * 7 + 10000} of them, version 2.{d} " + prose(rng, 10)
        docs[d] = text
    got = added(rows(pii.pii_report(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))), "id")
    assert got == want


def test_long_words_and_long_identifiers(spark):
    long = "w" * 70 + ":"
    docs = [(i, f"my {long} user{i}@host.org ok") for i in range(40)] + [(100, f"my {long} {'k7' * 60} ok")]
    got = rows(pii.pii_report(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[100]["spans"] == f"id:{4 + len(long)}:{4 + len(long) + 120}"
    secret = spark.createDataFrame([(1, f"client_id={'q' * 90} and token = abcdef")], "doc_id long, text string")
    assert secret_scan.secret_report(secret).first()["spans"] == "id:0:100,assign:105:119"


WEAK = [
    ("id", r"""(?<![A-Za-z0-9])(?i:access_?key_?id|client_?id|account_?id|user_?(?:name|id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", lambda s: True),
    ("user", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (
        "endpoint",
        r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9])(?i:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.]*[0-9])""",
        lambda s: True,
    ),
]
#: Credentials in parts, and texts where a part of one stands alone.
PLANTED = {
    10**6: "login: bob7\ntoken=abcdef123",
    10**6 + 1: "ann@corp.example token=abcdef123",
    10**6 + 2: "ann@corp.example token=abcdef123 https://db.example/x",
    10**6 + 3: "see https://x.example and token=abcdef1",
    10**6 + 4: "mail ann@corp.example, user_name = ann, secret: qwertyuiop",
    10**6 + 5: "ann@corp.example\n\ntoken=abcdef123 https://db.example/x",
}


def test_linked_parts_against_brute_force(spark):
    """Names and mails of accounts: they count where a base secret is within reach in their scope, mails only beside an
    endpoint or another name."""
    from .test_text_operators import SECRETS

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([*PLANTED.items()], "doc_id long, text string"))
    want = set()
    for d, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()):
        cuts = [m.start() for m in re.finditer(r"\n[ \t]*\n\s*|\n(?=\[[^\]\n]+\])|\n(?=---|===|#)", t)]
        scope = lambda x: sum(c <= x for c in cuts)  # noqa: B023, E731
        parts = lambda kinds: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans(t, kinds).split(",") if x)]  # noqa: B023, E731
        secrets, weak = parts(SECRETS), parts(WEAK)
        for name, s, e in weak:
            near = {k for k, a, b in secrets + weak if scope(a) == scope(s) and a <= e + 400 and b >= s - 400 and (a >= e or b <= s)}
            able = near & {"assign", "hex"} and (name == "id" or near & {"id", "access", "endpoint"})
            if name != "endpoint" and able and not any(a < e and s < b for _, a, b in secrets):
                want.add((d, name, s, e))
    got = {(d, k, *x) for d, r in rows(secret_scan.secret_report(docs)).items() for k in ("id", "user") for _, *x in added({d: r}, k)}
    assert got == want
    assert {(d, k) for d, k, *_ in got if d in PLANTED} == {(10**6, "id"), (10**6 + 2, "user"), (10**6 + 4, "id"), (10**6 + 4, "user")}


def test_scopes_and_entropy(spark):
    key, word = "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "zzzzzzzzzzzzzzzzzzzzzzzzzzzz1"
    docs = [(1, f"login: bob7\n\n{key}"), (2, f"login: bob7\n{key}"), (3, f"login: bob7 {word}"), (4, f"ann@corp.example {key} 10.0.0.7:5432"), (5, "ann@corp.example 10.0.0.7:5432"), (6, f"[a]\nlogin=bob7\n[b]\nx={key}")]
    got = {d: [x.split(":")[0] for x in r["spans"].split(",") if x] for d, r in rows(secret_scan.secret_report(spark.createDataFrame(docs, "doc_id long, text string"))).items()}
    assert got == {1: [], 2: ["id", "key"], 3: [], 4: ["user", "key", "endpoint"], 5: [], 6: []}


def test_what_base_rules_refuse_is_not_found_again(spark):
    """Cards teach their shape; numbers of that shape that fail the check digit stand alone and stay out, while cards that ran
    into their neighbours, which no base pattern judged by themselves, come back."""
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220"]
    rows = [(i, f"paid with {c} today") for i, c in enumerate([*good] * 4)]
    rows += [(100, "paid with 4111111111111112 today"), (101, "order 5500005555555558, thanks"), (102, "ends 4012888888881882"), (103, "999.1.2.300 and +1 23")]
    rows += [(200, "paid with 4111111111111111 4111111111111111 today")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("kind IS NOT NULL").collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.kind, r.start, r.end))
    assert all(by[i] == [("card", 10, 26)] for i in range(20))
    assert not {100, 101, 102, 103} & by.keys()
    assert sorted(by[200]) == [("id", 10, 26), ("id", 27, 43)]


def test_identifiers_of_many_words_short_ones_and_mails_without_digits(spark):
    """Cards in four groups are seeds and are found; mails without digits teach contexts; a run of 22 words is found whole; four
    letters and digits are an identifier in their place only."""
    cards = ["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881", "5105 1051 0510 5100", "4222 2222 2222 2220"]
    rows = [(i, f"pay card {c} today") for i, c in enumerate(cards * 2)]
    rows += [(50, f"pay card {cards[0]} {cards[2]} today")]
    rows += [(100 + i, f"the door code is {a}{b}@host.org here") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "klmnopq")]
    run = " ".join(f"k{k}" for k in range(310, 332))
    rows += [(200, f"the door code is {run} here"), (201, "the door code is k471 here"), (202, "in chapter k471 they meet")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'id'").collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(x) for d, x in by.items()} == {50: [(9, 28), (29, 48)], 200: [(17, 17 + len(run))], 201: [(17, 21)]}
