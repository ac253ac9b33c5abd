"""codeloom.streaming"""
