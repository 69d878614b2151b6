"""pagegrid.sources"""
