"""Graph, policy, resolution and mining operators over DataFrames."""
