"""Inputs: synthetic grids, tiles, contexts, forecasts and polygons."""
