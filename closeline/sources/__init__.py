"""closeline.sources"""
