"""DataFrame operators: labels, geometry, order, structure, Fourier, statistics and velocity fields."""
