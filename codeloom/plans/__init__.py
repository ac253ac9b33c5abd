"""codeloom.plans"""
