"""closeline.streaming"""
