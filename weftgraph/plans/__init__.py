"""From syntax trees to DataFrames: statistics, order of joins, compilation."""
