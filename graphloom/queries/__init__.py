"""graphloom.queries"""
