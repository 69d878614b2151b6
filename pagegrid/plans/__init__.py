"""pagegrid.plans"""
