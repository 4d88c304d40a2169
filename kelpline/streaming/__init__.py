"""kelpline.streaming"""
