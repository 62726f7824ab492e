"""settlegrid.functions"""
