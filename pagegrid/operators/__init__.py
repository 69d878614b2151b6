"""pagegrid.operators"""
