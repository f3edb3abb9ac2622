"""cardloom.sources"""
