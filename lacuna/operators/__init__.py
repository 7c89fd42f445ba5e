"""Operators over series: gaps, preprocessing, imputation, spectra, metrics, features, statistics, classifiers."""
