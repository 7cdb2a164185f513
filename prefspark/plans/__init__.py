"""End-to-end compositions of the operators (the three flows of SURVEY section 3)."""
