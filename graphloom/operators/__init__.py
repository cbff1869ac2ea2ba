"""graphloom.operators"""
