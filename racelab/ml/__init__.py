"""racelab.ml"""
