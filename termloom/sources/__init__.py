"""termloom.sources"""
