"""pagegrid.functions"""
