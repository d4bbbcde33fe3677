"""Rules of the recorded game: positions, legal moves, notation. No Spark here."""
