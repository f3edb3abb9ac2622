"""cardloom.functions"""
