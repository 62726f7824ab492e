"""settlegrid.sources"""
