"""Stages that turn scenarios into accepted results."""
