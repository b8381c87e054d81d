"""Content and activity analytics as Spark DataFrame transforms: each takes and returns DataFrames, and an explicit ``as_of`` where time matters."""
