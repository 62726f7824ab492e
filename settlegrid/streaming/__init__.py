"""settlegrid.streaming"""
