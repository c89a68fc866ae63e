"""Joins by distance, as equi-joins over grid cells.

Catalyst plans a distance predicate alone as a nested loop; with cells it is a hash or sort-merge join whose skew
adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.sources.settled import settled


def _row_gap(a: Column, b: Column, height: float | None) -> Column:
    gap = F.abs(a - b)
    return gap if height is None else F.least(gap, F.lit(float(height)) - gap)


def range_self_join(points: DataFrame, radius: float | Column, height: float | None = None, by: str = "frame", key: str = "region_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``frame, i, j, distance`` (and ``keep`` columns with _i and _j): pairs i < j at most ``radius`` apart.

    ``radius`` may be a column of the frame.  With ``height``, rows wrap; the radius must then be at most half of it.
    A pair meets once: cells are as wide as the radius, and each point on the right stands in the nine around it."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    p = points.withColumn("__r", r.cast("double"))
    if height is not None:
        p = p.withColumn("row", F.pmod(F.col("row"), F.lit(float(height))))
        # whole cells around the seam, each at least as tall as the radius
        n = F.greatest(F.lit(1.0), F.floor(F.lit(float(height)) / F.col("__r")))
        tall = F.lit(float(height)) / n
    else:
        n, tall = F.lit(None).cast("double"), F.col("__r")
    p = p.withColumn("__n", n).withColumn("__cr", F.floor(F.col("row") / tall)).withColumn("__cc", F.floor(F.col("col") / F.col("__r")))
    left = p.select(F.col(by), F.col(key).alias("i"), F.col("row").alias("__row_i"), F.col("col").alias("__col_i"), F.col("__cr"), F.col("__cc"), F.col("__r"), *[F.col(c).alias(f"{c}_i") for c in keep])
    around = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    rows = F.transform(around, lambda d: F.col("__cr") + d)
    if height is not None:
        rows = F.array_distinct(F.transform(rows, lambda x: F.pmod(x.cast("double"), F.col("__n")).cast("long")))
    right = p.select(F.col(by), F.col(key).alias("j"), F.col("row").alias("__row_j"), F.col("col").alias("__col_j"), "__cc", F.explode(rows).alias("__cr"), *[F.col(c).alias(f"{c}_j") for c in keep])
    right = right.withColumn("__cc", F.explode(F.transform(around, lambda d: F.col("__cc") + d)))
    distance = F.hypot(_row_gap(F.col("__row_i"), F.col("__row_j"), height), F.col("__col_i") - F.col("__col_j"))
    pairs = left.join(right, [by, "__cr", "__cc"]).where(F.col("i") < F.col("j")).withColumn("distance", distance)
    return pairs.where(F.col("distance") <= F.col("__r")).select(by, "i", "j", "distance", *[f"{c}_{s}" for c in keep for s in "ij"])


def knn_self_join(points: DataFrame, k: int, height: float | None = None, by: str = "frame", key: str = "region_id", keep: tuple[str, ...] = (), per_cell: float = 2.0) -> DataFrame:
    """``frame, i, j, d2, rank``: each point's ``k`` nearest others (fewer if its frame has fewer), ties by id.

    A point looks at the cells around it.  Cells have about ``per_cell`` points on average; they begin at a third of that
    width, for where points crowd, and those points whose k-th neighbour may lie outside of their ring look again on cells
    three times as wide, until a ring spans the frame.  So pairs stay in proportion to points, dense or far from all others.
    Only what is open after that (coordinates that are missing) meets its whole frame.  With ``height``, rows wrap, and a point reached through two images
    counts once, at its least distance."""
    box = points.groupBy(by).agg(F.count("*").alias("__n"), F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1"))
    tall = F.lit(float(height)) if height is not None else F.col("__r1") - F.col("__r0")
    wide = F.col("__c1") - F.col("__c0")
    side = F.greatest(F.sqrt(F.greatest(tall, F.lit(1e-9)) * F.greatest(wide, F.lit(1e-9)) / F.greatest(F.lit(1.0), F.col("__n") / per_cell)), F.greatest(tall, wide) / 4096, F.lit(1e-9))
    box = box.withColumn("__side", side)
    p = points.join(box.select(by, "__n", "__side", F.col("__r0").alias("__top"), F.col("__c0").alias("__left")), by)
    row0 = F.lit(0.0) if height is not None else F.col("__top")
    if height is not None:
        p = p.withColumn("row", F.pmod(F.col("row"), F.lit(float(height))))
        images = p.select("*", F.explode(F.array(*[F.lit(float(x)) for x in (-height, 0.0, height)])).alias("__shift")).withColumn("row", F.col("row") + F.col("__shift"))
    else:
        images = p
    other = images.select(by, F.col(key).alias("j"), F.col("row").alias("__row_j"), F.col("col").alias("__col_j"), F.col("__side"), row0.alias("__row0"), "__left", *[F.col(c).alias(f"{c}_j") for c in keep])
    todo = p.where(F.col("__n") > 1).select(by, F.col(key).alias("i"), F.col("row").alias("__row_i"), F.col("col").alias("__col_i"), "__side", "__n", row0.alias("__row0"), "__left")
    ring = max(1, int((k / (per_cell * 2)) ** 0.5) + 1)
    done = None
    nearest = Window.partitionBy(by, "i").orderBy("d2", "j")
    d2 = F.pow(F.col("__row_i") - F.col("__row_j"), F.lit(2)) + F.pow(F.col("__col_i") - F.col("__col_j"), F.lit(2))
    step = F.sequence(F.lit(-ring), F.lit(ring))
    # the widest side is 4096 of the narrowest, and the diagonal is less than twice that
    for level in (*range(-1, 9), None):
        if level is None:
            met = todo.join(other.drop("__side", "__row0", "__left"), by)
        else:
            side = F.col("__side") * 3.0**level
            cell = lambda df, s: df.withColumn("__cr", F.floor((F.col(f"__row_{s}") - F.col("__row0")) / side)).withColumn("__cc", F.floor((F.col(f"__col_{s}") - F.col("__left")) / side))  # noqa: B023, E731
            probe = cell(todo, "i").withColumn("__dr", F.explode(step)).withColumn("__dc", F.explode(step)).withColumn("__cr", F.col("__cr") + F.col("__dr")).withColumn("__cc", F.col("__cc") + F.col("__dc"))
            met = probe.join(cell(other, "j").drop("__side", "__row0", "__left"), [by, "__cr", "__cc"])
        near = met.where(F.col("i") != F.col("j")).select(by, "i", "j", d2.alias("d2"), "__n", "__side", *[f"{c}_j" for c in keep])
        if height is not None:
            near = near.groupBy(by, "i", "j").agg(F.min("d2").alias("d2"), *[F.first(c).alias(c) for c in near.columns[4:]])
        good = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        if level is not None:
            # the nearest k are certain if the last of them is no farther than the ring reaches
            whole = Window.partitionBy(by, "i")
            sure = (F.max("rank").over(whole) >= F.least(F.lit(k), F.col("__n") - 1)) & (F.sqrt(F.max("d2").over(whole)) <= ring * F.col("__side") * 3.0**level)
            good = settled(good.withColumn("__sure", sure).where("__sure").drop("__sure"))
            todo = settled(todo.join(good.where(F.col("rank") == 1), [by, "i"], "left_anti"))
        good = good.drop("__n", "__side")
        done = good if done is None else done.unionByName(good)
        if level is not None and todo.isEmpty():
            break
    return done


def nearest_join(points: DataFrame, samples: DataFrame, by: str, key: str, keep: tuple[str, ...], per_cell: float = 2.0, reach: int = 2) -> DataFrame:
    """``points`` (with x, y) and the ``keep`` columns of the nearest of ``samples`` (with sx, sy): inner, ties by sx, sy.

    Cells of about ``per_cell`` samples a group; a point looks at the cells around it, and the few for which that leaves
    it open (outside of all samples) look at their whole group.  ``key`` tells points of a group apart."""
    box = samples.groupBy(by).agg(F.count("*").alias("__n"), F.min("sx").alias("__x0"), F.max("sx").alias("__x1"), F.min("sy").alias("__y0"), F.max("sy").alias("__y1"))
    wide, tall = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    side = F.greatest(F.sqrt(F.greatest(tall, F.lit(1e-9)) * F.greatest(wide, F.lit(1e-9)) / F.greatest(F.lit(1.0), F.col("__n") / per_cell)), F.greatest(tall, wide) / 4096, F.lit(1e-9))
    box = box.select(by, side.alias("__side"), "__x0", "__y0")
    cell = lambda df, x, y: df.withColumns({"__cx": F.floor((F.col(x) - F.col("__x0")) / F.col("__side")), "__cy": F.floor((F.col(y) - F.col("__y0")) / F.col("__side"))})
    told = F.struct("sx", "sy", *keep)
    other = cell(samples.join(box, by), "sx", "sy").select(by, "__cx", "__cy", told.alias("__s"))
    todo = cell(points.join(box, by), "x", "y").withColumnsRenamed({"__cx": "__px", "__cy": "__py"})
    d2 = F.pow(F.col("x") - F.col("__s.sx"), F.lit(2)) + F.pow(F.col("y") - F.col("__s.sy"), F.lit(2))
    step = F.sequence(F.lit(-reach), F.lit(reach))
    probe = todo.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step)).withColumn("__cx", F.col("__px") + F.col("__dx")).withColumn("__cy", F.col("__py") + F.col("__dy"))
    best = lambda met: met.groupBy(by, key).agg(F.min(F.struct(d2.alias("d2"), "__s")).alias("__b"), F.first("__side").alias("__w"))
    # the nearest is certain if it is no farther than the cells reach
    near = settled(best(probe.join(other, [by, "__cx", "__cy"])).where(F.sqrt("__b.d2") <= reach * F.col("__w")))
    far = best(todo.join(near.select(by, key), [by, key], "left_anti").join(other, by))
    return points.join(near.unionByName(far).select(by, key, *[F.col(f"__b.__s.{c}").alias(c) for c in keep]), [by, key])
