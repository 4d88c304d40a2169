"""kelpline.sources"""
