"""cardloom.streaming"""
