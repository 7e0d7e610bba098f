"""Retail price monitoring on Spark: who is cheapest, how deep discounts are, how prices moved, what margin is left.

Functions take and return DataFrames and run no Spark action (the one exception is the writer in
``sources.encrypted``). A frame that still has its ``country`` column is analysed per country; a frame cut to one
market with ``operators.slicing.market_slice`` is analysed as that market.
"""
