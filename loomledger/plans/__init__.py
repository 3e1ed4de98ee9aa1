"""From a question to a query specification to a DataFrame."""
