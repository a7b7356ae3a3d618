"""Programs that combine operators: strategy choices, fits, cubes."""
