"""Column names that graphs and results use. They are part of the public interface."""

SRC, DST, ID = "src", "dst", "id"
MSG, VALUE = "msg", "value"
COMPONENT, DEGREE, RANK, SOURCE, LABEL = "component", "degree", "rank", "source", "label"
CORE, LANDMARK, DISTANCE, SELECTED = "core", "landmark", "distance", "selected"
TRIANGLES, HOP, APPROX, CLUSTER = "triangle_count", "hop", "approx_count", "cluster"
KIND, BIAS, FACTOR = "kind", "bias", "factor"
ORIGINAL = "original_id"
FROM, TO = "from", "to"
