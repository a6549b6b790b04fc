"""Result tables. Each function takes model tables and returns a DataFrame."""
