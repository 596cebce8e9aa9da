"""DataFrame operators: cleaning, features, models, risk, contracts."""
