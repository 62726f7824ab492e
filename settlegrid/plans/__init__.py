"""settlegrid.plans"""
