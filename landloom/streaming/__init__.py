"""On-demand reading of stored tiles.

The data is bounded; what streams is the viewer's position. A read prunes to
the tile partitions under a world box.
"""
