"""Operators: statistics, linear algebra, features, learning, clustering, mining, graphs and boosting."""
