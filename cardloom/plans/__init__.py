"""cardloom.plans"""
