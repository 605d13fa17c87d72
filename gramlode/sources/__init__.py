"""Readers: advert records, archives, keyword sheets, labels, years."""
