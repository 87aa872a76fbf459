"""Reading raw extracts and writing processed tables."""
