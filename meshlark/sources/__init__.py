"""Files and tables as frames, pixels, regions and velocity fields."""
