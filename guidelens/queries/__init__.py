"""The driver's queries of the amplicon engine, with their SQL."""
