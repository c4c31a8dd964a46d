"""closeline.functions"""
