"""foliospark.streaming"""
