"""closeline.operators"""
