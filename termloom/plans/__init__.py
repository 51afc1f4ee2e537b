"""termloom.plans"""
