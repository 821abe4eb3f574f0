"""chordgrid: images as pixels, points, neighbour graphs and chords, computed with Spark DataFrames."""
