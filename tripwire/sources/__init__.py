"""Table sources: raw parquet tables and the derived messages / transactions / command_log views."""
