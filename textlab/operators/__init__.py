"""Operators: rules, statistics, splits, features, evaluation, trees and training, as DataFrame jobs."""
