"""termloom.operators"""
