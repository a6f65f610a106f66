"""Readers and writers of point clouds."""
