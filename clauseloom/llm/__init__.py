"""Operators of a training-data pipeline: tokens, chats, duplicates, packing, secrets, filters, neighbours."""
