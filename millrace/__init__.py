"""Millrace: the data jobs of a small analytics platform, written for Spark.

Topics become tables, real-time tables keep segments and retention, warehouse
tables are created, appended to and reset, SQL text is run, dashboards and a
decision-support pack are answered, and Spark's own event logs are summarised.
"""
