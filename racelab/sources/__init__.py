"""racelab.sources"""
