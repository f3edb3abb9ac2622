"""cardloom.operators"""
