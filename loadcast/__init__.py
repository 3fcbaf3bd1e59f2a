"""loadcast: climate-driven electricity demand forecasting as Spark jobs."""
