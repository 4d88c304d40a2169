"""kelpline.plans"""
