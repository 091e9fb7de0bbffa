"""Where traces come from: tables, CSV files, packet captures; and guessing their schema."""
