"""Spark-native operators for labelled point clouds, label rasters and their evaluation."""
