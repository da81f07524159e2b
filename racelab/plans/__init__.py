"""racelab.plans"""
