"""Relational operators: statistics, metrics, neighbour search, rules, votes, evaluation."""
