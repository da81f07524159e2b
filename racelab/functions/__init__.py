"""racelab.functions"""
