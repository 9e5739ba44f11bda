"""Operators over findings, crashes, graphs, traces and campaigns."""
