"""Dialogue localisation over large collections of time-coded text, as Spark plans."""
