"""Operators over skeletons, fragments, scores, coverage and voxels."""
