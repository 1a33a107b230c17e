"""Training-data operators: ten text operators, their registered queries and comparison SQL."""
