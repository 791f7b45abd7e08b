"""Spark-native search over tree-shaped 3-D skeletons, and its data operators."""
