FLAGSHIP = "verdict_by_source"
