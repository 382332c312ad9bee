"""foliospark.sources"""
