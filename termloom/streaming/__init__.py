"""termloom.streaming"""
