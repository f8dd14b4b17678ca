"""Operators: pure DataFrame -> DataFrame functions (staging, marts, ranking, metrics...)."""
