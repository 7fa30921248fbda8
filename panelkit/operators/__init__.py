"""Analytic operators: plain DataFrame -> DataFrame functions."""
