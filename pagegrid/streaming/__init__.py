"""pagegrid.streaming"""
