"""racelab.operators"""
