"""settlegrid.operators"""
