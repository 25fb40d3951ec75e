"""Jobs composed of operators, the stand-in fixtures, and the query registry."""
