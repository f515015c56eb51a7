"""Seismark: evenly sampled time series, triggers, catalogs and station metadata as Spark DataFrames."""
