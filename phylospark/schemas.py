"""Schemas of the logical tables."""

ABUNDANCE = "sample_id string, feature_id string, count double"
SAMPLES = "sample_id string, ord int"
CLOSURE = "feature_id string, node_id string, length double, is_tip boolean"
NODES = "node_id int, parent_id int, name string, length double, is_tip boolean, depth int, subtree_end int, ancestors array<int>"
DISTANCE = "rep int, sample_i string, sample_j string, ord_i int, ord_j int, distance double"
