"""racelab.streaming"""
