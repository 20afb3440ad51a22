"""Query plans: KPI views, EDA queries, the pipeline and the query registry."""
