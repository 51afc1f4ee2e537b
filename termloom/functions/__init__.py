"""termloom.functions"""
