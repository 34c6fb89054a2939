"""Column expressions: KPI formulas, ratios, scores and effect curves."""
